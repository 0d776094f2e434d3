"""Collocations, source divergence and token files against brute force."""

import collections
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from tickloom.llm import collocations, divergence, token_files  # noqa: E402
from tickloom.llm.tables import new_path  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n int, w1 string, term string, id string"  # names used inside


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def mixed(seed, n, words, sources=3):
    rng = random.Random(seed)
    marks = [" ", " ", " ", " ", "  ", "\t", ". ", ", ", "\n", "! ", "é", " É"]
    rows = []
    for k in range(n):
        text = "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.choice([0, 1, 2, 5, 30, 80])))
        rows.append((k, text, rng.choice(["en", "de", "", None]), rng.choice([*(f"s{i}" for i in range(sources)), None, ""])))
    return rows + [(5, None, "fr", "s1"), (6, "", "fr", None), (7, "only once", "es", "s0"), rows[0], rows[0]]


def brute_collocations(rows, least=10, most=2000):
    count, total = collections.Counter(), collections.Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    count[(lang, tuple(w[i : i + k]))] += 1
    out = []
    for (lang, p), a in count.items():
        if len(p) < 2 or a < least:
            continue
        if len(p) == 2 and any(c >= least and 100 * c >= 50 * a for (g, q), c in count.items() if g == lang and len(q) == 3 and (q[:2] == p or q[1:] == p)):
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = count[(lang, p[:k])], count[(lang, p[k:])]
            cuts.append((1000000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(p), a, left, right, total[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:most]
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(own)]
    return sorted(ranked)


@pytest.mark.parametrize("bits", [collocations.FILTER_BITS, 16])
def test_collocations(spark, bits):
    words = ["the", "The", "of", "a", "b", "new", "york", "ß", "c-d", "'"]
    rows = mixed(1, 150, words)
    rows += [(900 + k, "once upon a time " * 3 + f"w{k} w{k + 1}", "en", "s0") for k in range(40)]  # rare words, a frequent passage
    found = collocations.collocations(table(spark, rows)) if bits > 16 else None
    if found is None:  # a filter of few bits lets rare phrases pass, which changes nothing
        w, p, _ = collocations.frequent_phrases(table(spark, rows), filter_bits=bits)
        v, q, _ = collocations.frequent_phrases(table(spark, rows))
        assert sorted(map(str, w.collect())) == sorted(map(str, v.collect()))
        assert sorted(map(str, p.collect())) == sorted(map(str, q.collect()))
        return
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = sorted(tuple(r) for r in found.collect())
    assert len(got) > 20 and got == brute_collocations(rows)


def test_collocations_of_nothing_and_of_long_texts(spark):
    assert collocations.collocations(table(spark, [])).count() == 0
    assert collocations.collocations(table(spark, [(1, None, None, None), (2, " \n.", "en", "s")])).count() == 0
    rows = [(1, "x y " * 300_000, "en", "s"), (2, "y" * 2_000_000, "en", "s"), (3, "p q r " * 12, None, "s")]
    assert sorted(tuple(r) for r in collocations.collocations(table(spark, rows)).collect()) == brute_collocations(rows)


def test_equal_parts():
    rng = np.random.default_rng(3)
    for n, values in ((0, 1), (40, 2), (3000, 9)):
        keys, weights = rng.integers(0, values, (4, n)), rng.integers(1, 4, n)
        keys[3][rng.random(n) < 0.2] = -1
        want = collections.Counter()
        for i in range(n):
            for d in range(4):
                if keys[d, i] < 0:
                    break
                want[tuple(keys[: d + 1, i].tolist())] += int(weights[i])
        depth, row, size = collocations.equal_parts(keys, weights, 10)
        got = {tuple(keys[: d + 1, r].tolist()): s for d, r, s in zip(depth.tolist(), row.tolist(), size.tolist(), strict=True)}
        assert len(depth) == len(got) and got == {k: v for k, v in want.items() if v >= 10}


def brute_divergence(rows, least=10, most=10):
    docs = collections.Counter()
    group, whole = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        docs.update((lang, t) for t in set(terms))
        group[lang, source].update(terms)
        whole[lang].update(terms)
    kept = {lang: [t for t in whole[lang] if docs[lang, t] >= least] for lang in whole}

    def shares(counts, lang):
        v, n = len(kept[lang]), sum(counts[t] for t in kept[lang])
        return {t: 1 + 10**9 * (counts[t] + 2) // (n + 2 * v) for t in kept[lang]}

    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang, source in group:
        p, q = shares(group[lang, source], lang), shares(whole[lang], lang)
        pairs = [(other, sum(f(p[t], x) for t, x in shares(group[lang, other], lang).items())) for g, other in group if g == lang and other != source]
        terms = [(t, f(p[t], q[t])) for t in kept[lang] if group[lang, source][t] > 0 and p[t] > q[t]]
        for part, rows_, limit in (("pair", pairs, None), ("term", terms, most)):
            ranked = sorted(rows_, key=lambda r: (-r[1], r[0].encode()))[:limit]
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("sources", [3, 140])
def test_source_divergence(spark, sources):
    """Beyond TILE sources several tiles meet; many terms share a cell, so that ties reach the report."""
    words = ["the", "The", "of", "a1b", "ñ", "x_y", *(f"w{chr(97 + k)}" for k in range(25))]
    rows = mixed(2, 260, words, sources) + [(2000 + k, " ".join(f"tie{c}" for c in "abcdefghijklmnop"), "en", f"s{k % 2}") for k in range(12)]
    found = divergence.source_divergence(table(spark, rows))
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    got, want = sorted(tuple(r) for r in found.collect()), brute_divergence(rows)
    assert len(want) > 40 and got == want


def test_source_divergence_of_odd_tables(spark):
    assert divergence.source_divergence(table(spark, [])).count() == 0
    rows = [(1, None, None, None), (2, "a b", None, "s"), (3, "é" * 400_000 + " b" * 200_000, "en", "s"), (4, "", "en", "t")]
    assert sorted(tuple(r) for r in divergence.source_divergence(table(spark, rows)).collect()) == brute_divergence(rows)


def test_shares_stay_exact_beyond_64_bits(spark):
    n, total, v = 7 * 10**13 + 3, 9 * 10**14 + 7, 10**8
    row = spark.createDataFrame([(n, total, v)], "c long, t long, v long").select(divergence.share("c", "t", "v").alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 2) // (total + 2 * v)


def test_codes_are_optimal_within_their_limit():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 50, 3000):
        counts = (rng.pareto(0.3, n) * 10 + 1).astype(np.int64) if n else np.zeros(0, np.int64)
        free, short = token_files.code_lengths(np.minimum(counts, 10**12), 40), token_files.code_lengths(np.minimum(counts, 10**12), 13)
        assert n < 2 or (sum(2.0 ** -int(x) for x in free) == 1.0 and sum(2.0 ** -int(x) for x in short) == 1.0 and short.max() <= 13)
        assert n < 2 or (free * np.minimum(counts, 10**12)).sum() <= (short * np.minimum(counts, 10**12)).sum()
    assert token_files.code_lengths(np.array([1, 1, 2, 4, 8, 16, 32]), 20).tolist() == [6, 6, 5, 4, 3, 2, 1]
    with pytest.raises(ValueError):
        token_files.code_lengths(np.ones(9, np.int64), 3)


def test_encoded_ids_come_back():
    rng = np.random.default_rng(6)
    ids = np.sort(rng.choice(60_000, 5000, replace=False))
    lengths = token_files.code_lengths((rng.pareto(0.4, 5000) * 5 + 1).astype(np.int64))
    assert lengths.max() == token_files.MAX_BITS
    coder = token_files.Coder(ids, lengths)
    for n in (1, 255, 256, 257, 20_000):
        drawn = rng.choice(ids, n)
        bits, marks, _ = coder.encode(drawn)
        stored = np.append(np.frombuffer(bits, ">u8").astype(np.uint64), np.uint64(0))
        sizes = np.minimum(token_files.CHECKPOINT, n - token_files.CHECKPOINT * np.arange(len(marks)))
        assert coder.decode(stored, marks, sizes).tolist() == drawn.tolist()


def test_token_files(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    model = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(model)
    rng = random.Random(8)
    words = ["Alpha", "beta", "\U0001f600", "ß", "123", "\n", "<|endoftext|>", "<|ENDOFTEXT|>", "a<|startoftext|>B", "DON'T", "x" * 50, "end.", "it's,", "é.", "don't", "a..", "1,", ".", ",.", "x\u00a0y.", "\u0301.", "A\u0301", "\u2028"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 300]))), None, None) for k in rng.sample(range(-50, 400), 300)]
    rows += [(1000, None, None, None), (1001, "long " * 200_000, None, None), (None, "no id", None, None), (None, None, None, None)]
    path = new_path(spark, "token_files")
    token_files.write_token_files(token_files.token_ids(table(spark, rows).repartition(7), model, 2, by_word=True), path, shards=5)
    whole = {r.id: bytes(r.ids) for r in token_files.token_ids(table(spark, rows), model, 2).where("id IS NOT NULL").collect()}
    got = token_files.read_token_files(spark, path).withColumn("crc", F.crc32("ids")).collect()
    at, want = 0, {}
    for key, text, _, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 2]
        if key is not None:
            want[key] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.id: (r.start, len(r.ids) // 4, r.crc) for r in got if r.id is not None} == want
    assert {r.id: bytes(r.ids) for r in got if r.id is not None} == whole
    assert sorted(len(r.ids) // 4 for r in got if r.id is None) == sorted(len([*own.encode(t or "", add_special_tokens=False).ids, 2]) for k, t, _, _ in rows if k is None)
    files = [f for f in Path(path.removeprefix("file://"), "blocks").glob("part-*")]
    assert 1 < len(files)
    data = bytearray(files[0].read_bytes())
    data[len(data) // 2] ^= 1
    files[0].write_bytes(data)
    for crc in files[0].parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="damaged"):
        token_files.read_token_files(spark, path)


def test_token_files_of_an_empty_table_and_repeated_ids(spark):
    empty = table(spark, []).select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("ids"))
    path = new_path(spark, "token_files")
    token_files.write_token_files(empty, path)
    assert token_files.read_token_files(spark, path).count() == 0
    same = spark.createDataFrame([(7, bytearray(np.array([5, 6], "<u4").tobytes()))] * 4 + [(7, bytearray())], "id long, ids binary")
    path = new_path(spark, "token_files")
    token_files.write_token_files(same, path, shards=3)
    got = token_files.read_token_files(spark, path).collect()
    assert sorted(len(r.ids) for r in got) == [0, 8, 8, 8, 8] and len({r.start for r in got if r.ids}) == 4
