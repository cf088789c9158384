"""Mixing, phrases and whitening against plain versions, and their defined cases."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitegrain.llm import mixing, phrases, queries, whitening

FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 977} tail{i % 977 % 31}" for i in range(40_000))
CLASHES = ["size", "sid", "mark", "bucket", "at", "blocks", "draws", "target", "weight", "part", "tag", "grams", "x", "i", "row", "n", "key", "f", "w1", "word"]


@pytest.fixture(scope="module")
def middle():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, LONG, "en", "a", len(LONG)),
        (5, "One small text of few words.", None, None, None), (5, "One small text of few words.", None, None, None), (5, "other", "en", "zz", 1),
        (None, "A text without an id, quite alone here.", "en", "a", 1), (7, "x", "xx", "b", 1), (8, "", "xx", "only blank", 0), (9, "naïve \U0001f600 café \x85 　 line", "fr", "é", 1),
    ]
    return spark.createDataFrame(rows, FIELDS).withColumns({c: F.lit("c") for c in CLASHES})


# --- mixing


def want_targets(sizes):
    """Water filling with fractions, round by round as the rule is told."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        share = {s: Fraction(rest * weight[s], sum(weight[x] for x in free)) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {s: float(v) for s, v in (capped | share).items()}
        capped |= {s: Fraction(3 * sizes[s]) for s in over}


def words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def held_to_rule(rows, got, near=0.002):
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += words(text)
    targets = want_targets(sizes)
    by = defaultdict(list)
    for doc, text, source in rows:
        by[doc, words(text), sizes[source]].append(targets[source])
    assert Counter((r.doc_id, r["size"], r.source_size) for r in got) == Counter({k: len(v) for k, v in by.items()})
    mix = Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        assert any(abs(r.target - t) <= 1e-9 * max(1, t) for t in by[r.doc_id, r["size"], r.source_size])
        mix[r.source_size, r.target] += r.taken
    for (size, target), n in mix.items():
        sources = sum(1 for s in sizes if sizes[s] == size and abs(targets[s] - target) < 1e-6 * max(1, target))
        assert abs(n - target * sources) <= max(1, near * target) * sources
    return sizes, targets


def test_mix_keeps_targets_and_agrees_with_itself(spark, middle):
    docs = spark.read.parquet(f"{middle}/documents.parquet").select("doc_id", "text", "source")
    first = queries.op11_mixing(spark, middle).collect()
    held_to_rule([tuple(r) for r in docs.collect()], first)
    again = mixing.taken(*mixing.mixed(docs.repartition(13))).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_mix_of_capped_and_hot_sources(spark):
    dice = random.Random(5)
    rows = [(i, " ".join("w" * dice.randint(1, 4) for _ in range(dice.randint(0, 60))), "hot" if i % 3 else f"s{dice.randint(0, 40)}") for i in range(900)]
    rows += [(1000, "one lone text", None), (1001, "tiny", "z\U0001f600"), (1002, "tiny too", "z￰")]
    sizes, targets = held_to_rule(rows, mixing.taken(*mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect())
    assert any(targets[s] == 3 * sizes[s] for s in sizes if sizes[s]) and targets["hot"] < sizes["hot"]


def test_shards_are_full_disjoint_and_hold_the_words(spark, middle, monkeypatch):
    monkeypatch.setattr(mixing, "LEVELS_A_STEP", 2)
    docs = spark.read.parquet(f"{middle}/documents.parquet")
    sources = mixing.targets(mixing.sizes(docs))
    nodes = mixing.quotas(sources, shard_blocks=700)
    blocks = mixing.dealt(nodes).collect()
    per_shard = Counter(r.shard for r in blocks)
    assert len(per_shard) > 16 and all(per_shard[s] == 700 for s in range(len(per_shard) - 1))
    assert all({r.slot for r in blocks if r.shard == s} == set(range(n)) for s, n in list(per_shard.items())[:3])
    for row in sources.collect():
        drawn = Counter(r.block for r in blocks if r.sid == row.sid)
        assert sum(drawn.values()) == row.draws
        # whole epochs first, then a part of one: counts of blocks differ by one at most
        assert set(drawn) <= set(range(row.blocks)) and max(drawn.values()) - (min(drawn.values()) if len(drawn) == row.blocks else 0) <= 1
    # sources spread over the shards as their quotas are: the share in each shard follows a draw without replacement
    big = max(sources.collect(), key=lambda r: r.draws)
    share = big.draws / len(blocks)
    inside = [sum(1 for r in blocks if r.shard == s and r.sid == big.sid) for s in range(len(per_shard) - 1)]
    assert all(abs(n - 700 * share) < 6 * (700 * share * (1 - share)) ** 0.5 for n in inside) and len(set(inside)) > 1


def test_mix_text_is_the_words_taken(spark, tmp_path):
    dice = random.Random(6)
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(dice.randint(0, 300))), f"s{i % 4}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixing.write_mix(docs, f"{tmp_path}/mix")
    found = Counter()
    for r in spark.read.parquet(f"{tmp_path}/mix").collect():
        found.update(r.text.split())
        assert all(w.startswith(f"d{r.doc_id}w") for w in r.text.split())
    want = {r.doc_id: r.taken for r in mixing.taken(*mixing.mixed(docs)).collect()}
    by_doc = Counter()
    for word, n in found.items():
        assert n <= 3
        by_doc[int(word[1 : word.index("w")])] += n
    assert by_doc == Counter({d: n for d, n in want.items() if n})


def test_permutation_is_one():
    for size in (1, 2, 3, 7, 64, 1000, 4097):
        out = mixing.permuted(np.arange(size), size, [1, size])
        assert sorted(out.tolist()) == list(range(size))
    assert mixing.permuted(np.arange(1000), 1000, [1]).tolist() != mixing.permuted(np.arange(1000), 1000, [2]).tolist()


def test_odd_rows_in_the_mix(spark, odd):
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    held_to_rule(rows, mixing.taken(*mixing.mixed(odd)).collect())
    assert mixing.taken(*mixing.mixed(odd.limit(0))).count() == 0
    assert [r.taken for r in mixing.taken(*mixing.mixed(odd.filter("doc_id = 8"))).collect()] == [0]
    assert mixing.texts_of(odd, mixing.mixed(odd)[1]).filter("doc_id = 4").count() > 0


# --- phrases


def plain_phrases(rows, least=10, top=2000):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        rows = []
        longer = defaultdict(int)
        for p, a in f.items():
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    longer[q] = max(longer[q], a)
        for p, a in f.items():
            if len(p) < 2 or a < least or (len(p) == 2 and 100 * longer[p] >= 50 * a and longer[p] >= least):
                continue
            s, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), left, right))
        for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def test_phrases_like_brute_force(spark, middle):
    docs = spark.read.parquet(f"{middle}/documents.parquet")
    got = sorted(map(tuple, queries.op12_phrases(spark, middle).collect()))
    assert got == plain_phrases([(r.text, r.lang) for r in docs.select("text", "lang").collect()]) and len(got) > 100


def test_phrases_whatever_the_chunks_parts_and_sieve(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_WORDS", 64)
    monkeypatch.setattr(phrases, "CHUNK_VOCABULARY", 24)
    dice = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "x,y", "Ab", " ", "a\tb", ".", "\x85", "\n"]
    rows = [(" ".join(dice.choice(vocabulary[: dice.choice([3, 10, 48])]) for _ in range(dice.randint(0, 400))), dice.choice(["en", "de", None])) for _ in range(120)]
    rows += [("  " * 300 + "hot phrase here. ", "en")] * 300 + [(None, "en"), ("", None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    want = plain_phrases(rows)
    assert len(want) > 50
    for how in ({"parts": 1}, {"parts": 7, "slack": 1}, {"parts": 5, "most_bits": 1}):
        got = phrases.collocations(docs, **how)
        assert sorted(map(tuple, got.collect())) == want


def test_phrases_are_sent_some_bytes_at_a_time(monkeypatch):
    monkeypatch.setattr(phrases, "SENT_BYTES", 20_000, raising=False)
    dice = np.random.default_rng(5)
    text = " ".join(f"w{i}" for i in dice.integers(0, 20_000, 60_000))
    batch = pa.RecordBatch.from_arrays([pa.array([text.encode()] * 2), pa.array(["en", "en"])], ["text", "lang"])

    class Frame:
        def mapInArrow(self, run, schema):
            return list(run(iter([batch])))

    grams = [Counter(zip(*(text.split()[i:] for i in range(n)))) for n in (1, 2, 3)]
    for sent, first in ((phrases._packed(Frame(), 16, 10, 3), True), (phrases._again(Frame(), 16, 3, None), False)):
        assert max(b.nbytes for b in sent) < 200_000 < sum(b.nbytes for b in sent)
        found, counts = ([x for b in sent for x in b.column(k).to_pylist() if x is not None] for k in ("grams", "counts"))
        if first:
            assert sum(len(x) for x in found) == 8 * sum(map(len, grams))
            assert sum(int(np.frombuffer(x, np.uint32).sum()) for x in counts) == sum(min(10, 2 * c) for g in grams for c in g.values())
            heads = [(r["mass"], r["words"]) for b in sent for r in b.to_pylist() if r["tag"] == 0]
            assert [sum(x) for x in zip(*heads)] == [sum(min(10, 2 * c) for g in grams for c in g.values()), 120_000]
        else:
            assert sum(int(np.frombuffer(x, np.uint32).sum()) for x in counts) == 2 * (60_000 + 59_999 + 59_998)


def test_summaries_lose_no_frequent_gram_and_little_of_any():
    dice = np.random.default_rng(3)
    stream = np.r_[dice.zipf(1.3, 60_000) % 30_000, np.arange(40_000)].astype(np.uint64)
    dice.shuffle(stream)
    capacity = 4 * len(stream) // 10 + 1
    for limit in (capacity, len(stream) // 10 + 1):
        parts = [phrases.Summary(limit) for _ in range(4)]
        for i, part in enumerate(parts):
            for at in range(i * 25_000, (i + 1) * 25_000, 1000):
                grams, counts = np.unique(stream[at : at + 1000], return_counts=True)
                part.add(grams, counts)
        whole = phrases.Summary(limit)
        for part in parts:
            part.merge()
            whole.add(part.grams, part.counts)
        lost = whole.lost + sum(p.lost for p in parts)
        whole.merge()
        lost = max(lost, whole.lost + sum(p.lost for p in parts))
        true = Counter(stream.tolist())
        known = dict(zip(whole.grams.tolist(), whole.counts.tolist()))
        assert lost <= len(stream) / (limit + 1)
        assert all(known.get(g, 0) <= n <= known.get(g, 0) + lost for g, n in true.items())
        assert {g for g, n in true.items() if n >= 10} <= set(known)
        assert len(whole.grams) <= limit


def test_scores_are_exact_beyond_64_bits(spark):
    dice = random.Random(2)
    rows = [(a, a + dice.randint(0, a), a + dice.randint(0, 10 * a)) for a in (10, 10**6 + 3, 10**12 + 39, 3 * 10**13 + 7) for _ in range(50)] + [(10**14, 10**14, 10**14)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", phrases.score("a", "l", "r").alias("s")).collect()
    assert all(r.s == 1_000_000 * r.a * r.a // (r.l * r.r) for r in got)


def test_odd_rows_in_phrases(spark, odd):
    got = sorted(map(tuple, phrases.collocations(odd).collect()))
    assert got == plain_phrases([(r.text, r.lang) for r in odd.collect()]) and got
    assert phrases.collocations(odd.limit(0)).count() == 0
    assert phrases.collocations(odd.filter("doc_id IN (1, 2, 3)")).count() == 0


# --- whitening


def plain_whitening(rows, count=4):
    usable = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    length = max(Counter(len(v) for _, v in usable).items(), key=lambda x: (x[1], x[0]))[0]
    x = [(i, tuple(int(np.floor(256 * float(c))) for c in v)) for i, v in usable if len(v) == length]
    fit = np.array(sorted({v for _, v in x}), object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit.astype(float) - sums.astype(float) / n)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:count]
    z = {(i, k + 1): float((np.array(v, float) - sums.astype(float) / n) @ vectors[:, j] / max(values[j], 1e-300) ** 0.5) for i, v in x for k, j in enumerate(order)}
    deviation = {i: int(((n * np.array(v, object) - sums) ** 2).sum()) for i, v in x}
    return n, deviation, z, values[order] / values.sum()


def same_whitening(got, rows):
    n, deviation, z, explained = plain_whitening(rows)
    assert {r.n for r in got} == {n} and {r.vec_id: r.deviation for r in got} == deviation
    assert {(r.vec_id, r.component) for r in got} == set(z) and len(got) == len(z)
    for k in {r.component for r in got}:
        a, b = zip(*[(r.whitened, z[r.vec_id, k]) for r in got if r.component == k])
        sign = np.sign(np.dot(a, b))
        assert np.abs(np.array(a) - sign * np.array(b)).max() < 1e-6
        assert all(abs(r.explained - explained[k - 1]) <= 1e-9 for r in got if r.component == k)
    assert all(r.identity_error <= 1e-10 for r in got)


def test_whitening_like_eigh(spark, middle):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{middle}/embeddings.parquet").collect()]
    same_whitening(queries.op13_whitening(spark, middle).collect(), rows)


def test_whitening_of_copies_and_odd_rows(spark, tmp_path):
    dice = np.random.default_rng(8)
    rows = [(i, dice.normal(size=5).tolist()) for i in range(300)] + [(1000 + i, [9.0, -3.0, 0.5, 0.25, 1.0]) for i in range(400)]
    odd = [(2001, None), (2002, []), (2003, [1.0, None, 1.0, 1.0, 1.0]), (2004, [1.0, float("nan"), 1.0, 1.0, 1.0]), (2005, [float("-inf")] * 5), (2006, [1.0, 2.0])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({c: F.lit("c") for c in CLASHES})
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    same_whitening(queries.op13_whitening(spark, str(tmp_path)).collect(), rows)


def test_whitening_without_variance(spark, tmp_path):
    def run(name, rows):
        spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        return queries.op13_whitening(spark, f"{tmp_path}/{name}").collect()

    assert run("none", []) == [] and run("null", [(1, None), (2, [])]) == []
    same = run("same", [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])])
    assert len(same) == 6 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 and r.n == 1 and r.identity_error is None for r in same)
    line = run("line", [(i, [float(i), 2.0 * i, 0.0]) for i in range(20)])
    assert all((r.whitened is not None) == (r.component == 1) for r in line) and len(line) == 60
    huge = run("huge", [(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [0.0, 1.0])])
    assert len(huge) == 6


@pytest.mark.parametrize("d", [1, 2, 7, 48])
def test_spectral_splitting(d):
    dice = np.random.default_rng(d)
    a = dice.standard_normal((d, 3 * d))
    for v in (a @ a.T, np.eye(d), np.diag(np.r_[5.0, np.ones(d - 1)]), np.zeros((d, d)), np.outer(a[:, 0], a[:, 0]), np.diag(np.arange(d) * 1e6), np.diag(np.r_[np.full(d // 2, -1.0), np.full(d - d // 2, 1.0)])):
        values, vectors = whitening.components(v)
        size = max(np.abs(values).max(), 1e-300)
        assert np.abs(values - np.linalg.eigvalsh(v)[::-1]).max() <= 1e-12 * size
        assert np.abs(vectors.T @ vectors - np.eye(d)).max() <= 1e-12 and np.abs(v @ vectors - vectors * values).max() <= 1e-12 * size
